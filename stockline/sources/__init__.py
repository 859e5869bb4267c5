"""Sources and sinks: table scans, the driver-table views, writers."""
