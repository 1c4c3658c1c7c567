"""Plan shaping: series windows, exact quantiles and the registered queries."""
