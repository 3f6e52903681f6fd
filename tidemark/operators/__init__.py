"""Column-parameterised DataFrame operators: boards, percentiles, metrics, folds, clustering, coverage, publishing."""
