"""Planning of batches."""
