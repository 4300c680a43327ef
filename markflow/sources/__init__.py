"""Sources and sinks: tables, rule files, class files, reports."""
