"""Scalar functions on columns: closed forms of survey physics, angles, labels and times."""
