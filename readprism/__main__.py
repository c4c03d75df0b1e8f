"""Run the command line."""

import sys

from readprism.cli import main

sys.exit(main())
