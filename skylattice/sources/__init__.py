"""Sources and sinks: frame streams, captures, outlines, frozen results."""
