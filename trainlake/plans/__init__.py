"""Jobs: ``build_*`` describe a table lazily, ``run_*`` read their inputs and write it."""
