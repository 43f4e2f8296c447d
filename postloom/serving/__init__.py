"""The read interface over HTTP, settings, logs, fixtures and the command line."""
