"""Planning helpers and the dataset API."""
