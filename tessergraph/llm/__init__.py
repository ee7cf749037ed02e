"""Operations for building training corpora: extraction, tokens, dedup, quality."""
