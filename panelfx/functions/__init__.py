"""Distribution functions without third-party packages."""
