"""bagweave: curation, grouping, splitting and evaluation of labelled bags of observations on Spark."""
