"""Load classifiers and regressors, and the experiment driver."""
