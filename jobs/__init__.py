"""Runnable jobs: each a function of a session and paths, a command line and a small config file."""
