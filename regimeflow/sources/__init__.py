from .events import EVENT_COLUMNS, assign_names, column_types, detect_header, event_schema, read_events, shape
from .sinks import write_delimited

__all__ = ["EVENT_COLUMNS", "assign_names", "column_types", "detect_header", "event_schema", "read_events", "shape",
           "write_delimited"]
