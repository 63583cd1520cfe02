"""python -m factlake.service COMMAND"""

import sys

from .api import main

sys.exit(main())
