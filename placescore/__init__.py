"""placescore: place scoring, spatial joins and data-quality jobs as Spark DataFrame transformations."""
