import sys

from scanloom.cli import main

sys.exit(main())
