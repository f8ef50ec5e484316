import sys

from kmerloom.plans.run import main

sys.exit(main())
