"""Writers: partitioned history, published tables, CSV appends, reports, logs."""
