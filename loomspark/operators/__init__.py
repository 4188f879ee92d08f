from .keys import assert_key, insert_returning, key_violations, with_serial  # noqa: F401
