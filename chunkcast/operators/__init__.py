"""DataFrame-to-DataFrame operators: prepare, fit, expand, combine, forecast, evaluate."""
