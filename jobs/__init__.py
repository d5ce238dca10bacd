"""Runnable jobs over the library's operators. Each has a function taking a session, a command line and a config file."""
