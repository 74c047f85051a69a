"""Model layer: splits, fitted imputers/scalers, regressors, evaluation, importance."""
