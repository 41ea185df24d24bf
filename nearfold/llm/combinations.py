"""The search for close words under its name here; images need it too, so it is one of the operators."""

import sys

from ..operators import combinations

sys.modules[__name__] = combinations
