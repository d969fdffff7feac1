from voltledger.plans.ingest import ingest, load_rejects, stored_inputs
from voltledger.plans.inputs import Inputs
from voltledger.plans.products import PRODUCTS
from voltledger.plans.publish import ordered, product, publish, publish_changes, published, reads, store_layers

__all__ = [
    "PRODUCTS",
    "Inputs",
    "ingest",
    "load_rejects",
    "ordered",
    "product",
    "publish",
    "publish_changes",
    "published",
    "reads",
    "store_layers",
    "stored_inputs",
]
