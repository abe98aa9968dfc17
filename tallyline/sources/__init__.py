"""Reading captures and storing tables."""
