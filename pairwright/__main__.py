import sys

from pairwright.cli import main

sys.exit(main())
