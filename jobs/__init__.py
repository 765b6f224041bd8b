"""Runnable jobs; each module has run(session, paths, config) and a command line."""
