"""Operations of a training-data pipeline, each built by one named method.

Nothing outside this subpackage imports it; ``__spark_entry__`` adds its
queries only when it can be imported. Modules:

* ``simhash``    SimHash near-duplicates by multi-index hashing (op1)
* ``sharding``   consistent-hash ring with bounded loads (op2)
* ``ann``        nearest neighbours over rotated one-bit codes (op3)
* ``itq``        embedding near-duplicates over ITQ codes (op4)
* ``secrets``    secret spans and a randomness test battery (op5)
* ``warc``       WARC archives and the merged capture index (op6)
* ``quality``    histogram gradient-boosted trees over text statistics (op7)
* ``extract``    main text of a page by composite text density (op8)
* ``packing``    sequence packing by a grouping genetic algorithm (op9)
* ``bpe``        byte-level BPE by prefix-sharing traversal (op10)
* ``common``, ``components``  shared helpers
* ``queries``    the registered queries and their SQL
"""
