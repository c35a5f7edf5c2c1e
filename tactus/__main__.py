"""``python -m tactus``: the command line."""

from tactus.plans.options import main

main()
