"""Detection rules over flow rows and the findings they make."""
