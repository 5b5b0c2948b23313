"""Parameter-driven runs, the command line and the registered queries."""
