from .jsoncodec import canonical_json, decode, encode, same_document  # noqa: F401
from .misc import health, unique_name  # noqa: F401
