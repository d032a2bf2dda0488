"""Small source trees for end-to-end tests."""

import os
import textwrap


def put(root, files):
    for name, text in files.items():
        path = os.path.join(str(root), name)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "w", encoding="utf-8") as f:
            f.write(textwrap.dedent(text).lstrip("\n"))
    return str(root)


C_TREE = {
    ".git/HEAD": "x\n",
    "main.c": """
        #include "util.h"
        int twin(int x);

        static int near_by(int x) {
            return x + 1;
        }

        int twin(int x) {
            return x;
        }

        int start(void) {
            near_by(1);
            far_off(2);
            return twin(3);
        }
        """,
    "util.c": """
        int leaf(int x) { return x; }

        int far_off(int x) {
            return leaf(x);
        }
        """,
    "other.c": """
        int twin(int x) {
            return 2 * x;
        }
        """,
    "tests/check.c": """
        int check(void) {
            return start();
        }
        """,
    "node_modules/skip.c": "int skipped(void) { return 0; }\n",
}

SERVER = {
    ".git/HEAD": "x\n",
    "package.json": '{"name": "@shop/orders"}',
    "index.js": "export const ready = () => true;\n",
    "routes.ts": """
        // serves /api/orders
        import express from 'express';
        const app = express();
        export function register() {
          app.post('/api/orders', (req, res) => save(req.body));
        }
        function save(order) {
          bus.publish('order.created', order);
          return process.env.ORDER_REGION_KEY;
        }
        """,
}
CLIENT = {
    ".git/HEAD": "x\n",
    "send.js": """
        import { ready } from '@shop/orders';
        export function send(order) {
          return fetch('/api/orders', { method: 'POST' });
        }
        export const again = async (order) => {
          await send(order);
          bus.subscribe('order.created', again);
          return process.env.ORDER_REGION_KEY + process.env.NODE_ENV;
        };
        """,
}
SPEC = """
    asyncapi: 3.0.0
    info: {title: orders}
    channels:
      orders:
        address: /api/orders
        x-any-producers: [client]
        x-any-consumers: [server]
        messages:
          one:
            payload:
              properties:
                order_total: {type: number}
                legacy_slot_id: {type: string}
    operations:
      create: {action: receive, messages: [{$ref: '#/channels/orders/messages/one'}]}
    """
