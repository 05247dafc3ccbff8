"""Registry of queries: name -> (callable of (spark, sf_dir), DuckDB SQL or None)."""

from strandline.queries import extras, formats, general, hmm, more, panel, sfs, sites

REGISTRY = {**general.QUERIES, **sites.QUERIES, **hmm.QUERIES, **sfs.QUERIES, **panel.QUERIES, **formats.QUERIES, **extras.QUERIES, **more.QUERIES}
