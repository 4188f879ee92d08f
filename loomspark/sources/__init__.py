from .connectors import jdbc_options, jdbc_reader, kafka_reader, kafka_reader_options, kafka_write, kafka_writer_options  # noqa: F401
from .tables import SessionTable, load, point_lookup, scalar  # noqa: F401
