"""Operations on training text: sharding, mixing, filtering, deduplication, extraction, tokens."""
