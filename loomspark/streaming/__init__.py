from .log import RECORD, Log, await_or_fail, first_message  # noqa: F401
