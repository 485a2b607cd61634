"""Word segmentation of unspaced text as Spark dataflow."""
