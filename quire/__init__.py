"""A PySpark engine for catalogues of talking books and other time-synchronised documents."""
