"""Analytics of English prose on Spark: style rules, n-gram features, clean-up and reports as DataFrame plans."""
