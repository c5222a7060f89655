"""DataFrame operators: profiling, cleaning, encoding, gating, splitting,
modelling, comparison, run logs and defect injection."""
