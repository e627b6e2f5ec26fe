"""Sources and sinks of price series, events, models and results."""
