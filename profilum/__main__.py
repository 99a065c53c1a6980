"""python -m profilum"""

import sys

from profilum.cli import main

sys.exit(main())
