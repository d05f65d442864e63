"""Operations of a training-data pipeline: dedup, language ID, token counts,
cleaning rules, WARC, mixing, personal data, resampling, segmentation and
exact vector search.  Nothing outside this subpackage imports it."""
