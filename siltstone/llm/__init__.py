"""Training-data operators: ten independent DataFrame operators over document tables."""
