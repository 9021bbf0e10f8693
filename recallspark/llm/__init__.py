"""Operations of a large text corpus pipeline: classifiers, duplicates, scans, tokens."""
