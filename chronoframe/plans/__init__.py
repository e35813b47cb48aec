"""Planning on the driver: statistics, bucket widths, granule counts."""
