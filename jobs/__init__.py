"""Runnable jobs: each module has ``run`` for a session and plain paths, and a command line."""
