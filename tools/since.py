"""Print the names of the queries a plans module registers."""
import importlib, os, sys
sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from barloom.plans.registry import REGISTRY
importlib.import_module("barloom.plans.catalog")
print(" ".join(n for n, q in REGISTRY.items() if q.plan.__module__.split(".")[-1] in sys.argv[1:]))
