"""Training-data operators; nothing else in lodestar imports this subpackage."""
