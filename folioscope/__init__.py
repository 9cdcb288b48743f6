"""folioscope: a Spark-first engine for corpora of interlinked Markdown pages."""
