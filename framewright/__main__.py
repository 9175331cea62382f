import sys

from framewright.cli import main

sys.exit(main())
