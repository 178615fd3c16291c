"""Sources and sinks: typed CSV, carrier layouts, price series, the synthetic world, report files."""
