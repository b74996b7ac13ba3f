"""DataFrame -> DataFrame operators of the receipt pipeline."""
