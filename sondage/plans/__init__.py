"""Join strategies: interval, as-of with interpolation, and proximity joins as equi-joins on buckets."""
