from knnhard.functions.vec import *  # noqa: F401,F403
from knnhard.functions.rand import *  # noqa: F401,F403
