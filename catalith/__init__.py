"""A Spark engine for catalogues of technical documents."""
