"""Script form of ``python -m flowwarden.jobs`` for spark-submit (``--py-files`` with the package)."""

from flowwarden.jobs import main

if __name__ == "__main__":
    main()
