"""Sources, sinks and tables in the shared folder."""
