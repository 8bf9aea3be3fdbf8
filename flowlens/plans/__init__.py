"""Query plans over the driver tables: each is (spark, sf_dir) -> DataFrame, plus the
equivalent DuckDB SQL used as the correctness oracle."""
