"""Row shaping and analytic operators."""
