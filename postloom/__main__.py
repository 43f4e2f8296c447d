import sys

from postloom.serving.commands import main

sys.exit(main(sys.argv[1:]))
