"""Search in sequences. Hits are struct<start, stop>, from 1, stop included; not found is null."""
