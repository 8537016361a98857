"""paperloom: document intelligence as lazy Spark DataFrame transformations."""
