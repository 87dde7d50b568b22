"""Record linkage on Spark: find every pool record that belongs to each reference entity."""
