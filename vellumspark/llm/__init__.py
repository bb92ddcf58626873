"""Operations of a training-data pipeline: tokens, language, duplicates, shards, search, quality, packing."""
