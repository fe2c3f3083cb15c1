"""Training-data operators: decontamination, packing, near-dedup, language ID, licences, WARC,
HTML text, language-model scores, personal data and exact top-k search.

Self-contained: nothing outside this folder and ``corpus_pipeline.py`` imports it.
"""

import sys

from pyspark import cloudpickle

# task functions travel with the plan, so executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
