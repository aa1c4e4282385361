"""Questionnaire and test analytics as Spark jobs.

Every operator takes DataFrames and returns DataFrames.  Long
``(id, item, value)`` frames are the canonical shape; wide frames appear only
where a report or a model needs them, always with declared columns.
"""

import sys

from pyspark import cloudpickle

# Arrow functions travel with the job, so executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
