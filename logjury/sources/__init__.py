from logjury.sources.lines import clean_lines, lines_of, number_lines, read_lines, stream_lines
from logjury.sources.ndjson import ndjson, write_ndjson
from logjury.sources.registry import AUTO, Descriptor, Line, Provider, Registry, UnknownSource
from logjury.sources.sink import NdjsonSink, run_to_sink

__all__ = [
    "AUTO",
    "Descriptor",
    "Line",
    "NdjsonSink",
    "Provider",
    "Registry",
    "UnknownSource",
    "clean_lines",
    "lines_of",
    "ndjson",
    "number_lines",
    "read_lines",
    "run_to_sink",
    "stream_lines",
    "write_ndjson",
]
