"""Column functions of the flow model."""
