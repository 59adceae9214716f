"""The registered queries of this package and their SQL."""

import corpus_pipeline
from tidebook.llm import queries

QUERIES = {name: f for name, f in vars(queries).items() if name.startswith("op")}
ORACLES = {name: sql for name in QUERIES if (sql := vars(queries).get(f"{name.split('_')[0].upper()}_SQL"))}

QUERIES["pipeline"] = lambda spark, sf_dir: corpus_pipeline.run(spark, sf_dir)
if corpus_pipeline.ORACLE_SQL is not None:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
