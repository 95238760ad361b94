"""The row-wise operators on streams."""
