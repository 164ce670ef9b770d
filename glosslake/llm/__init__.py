"""Training-data operators: sharding, language ID, URL filters, n-gram Jaccard
join, HTML extraction, decontamination, PII, exact top-k, packing, substring
dedup, vector codes, lexical search, toxicity.  Each module holds one operator and its ``opN_*`` query; ``registry``
collects the queries and their SQL."""
