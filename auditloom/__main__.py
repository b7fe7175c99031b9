import sys

from auditloom.cli import main

sys.exit(main())
