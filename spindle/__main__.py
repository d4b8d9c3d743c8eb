import sys

from spindle.cli import main

sys.exit(main())
