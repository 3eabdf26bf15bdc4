"""DataFrame operators: clean, features, labels, folds, forest, tune, score, evaluate."""
