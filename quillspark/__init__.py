"""Document and knowledge analytics as DataFrame-to-DataFrame functions."""
