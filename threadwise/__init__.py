"""threadwise: support-conversation analytics as PySpark DataFrame operators."""

import sys

from pyspark import cloudpickle

from threadwise.config import Settings
from threadwise.lexicon import Lexicon, support_lexicon
from threadwise.session import build_session, reliable, shared_folder

__all__ = ["Lexicon", "Settings", "build_session", "reliable", "shared_folder", "support_lexicon"]

# Functions of this package travel to executors by value, so they need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
