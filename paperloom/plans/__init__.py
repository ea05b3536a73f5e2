"""Multi-stage plans over operators."""
