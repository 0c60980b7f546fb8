"""Anomaly detectors (M1-M11): prepare, isolation forest, one-class SVM,
DBSCAN, reconstruction error, ensemble, explanation and report."""
