"""``python -m promolens ...``: the batch job (see :mod:`promolens.plans.jobs`)."""

from .plans.jobs import main

if __name__ == "__main__":
    main()
